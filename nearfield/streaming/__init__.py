"""nearfield.streaming"""
