"""rollbook.streaming"""
