"""deltaloom.operators"""
