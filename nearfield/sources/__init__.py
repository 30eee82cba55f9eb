"""nearfield.sources"""
