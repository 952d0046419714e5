"""lodestar.operators"""
