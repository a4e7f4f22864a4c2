"""claimloom.functions"""
