"""nearfield.plans"""
