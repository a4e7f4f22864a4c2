"""claimloom.operators"""
