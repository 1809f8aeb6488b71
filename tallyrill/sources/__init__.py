"""tallyrill.sources"""
