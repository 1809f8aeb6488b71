"""tallyrill.streaming"""
