"""deltaloom.sources"""
