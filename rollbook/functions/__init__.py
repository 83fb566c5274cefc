"""rollbook.functions"""
