"""deltaloom.plans"""
