"""lodestar.plans"""
