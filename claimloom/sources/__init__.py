"""claimloom.sources"""
