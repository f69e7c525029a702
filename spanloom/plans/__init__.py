"""spanloom.plans"""
