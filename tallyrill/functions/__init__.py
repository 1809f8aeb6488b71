"""tallyrill.functions"""
