"""claimloom.streaming"""
