"""rollbook.plans"""
