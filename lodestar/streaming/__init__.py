"""lodestar.streaming"""
