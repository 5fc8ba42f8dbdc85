"""deltaloom.functions"""
