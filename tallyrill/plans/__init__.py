"""tallyrill.plans"""
