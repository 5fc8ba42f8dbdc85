"""deltaloom.streaming"""
