"""rollbook.sources"""
