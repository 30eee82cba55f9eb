"""nearfield.operators"""
