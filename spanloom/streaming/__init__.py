"""spanloom.streaming"""
