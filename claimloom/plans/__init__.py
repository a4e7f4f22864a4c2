"""claimloom.plans"""
