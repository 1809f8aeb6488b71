"""tallyrill.operators"""
