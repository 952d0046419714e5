"""lodestar.functions"""
