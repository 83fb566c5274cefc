"""rollbook.operators"""
