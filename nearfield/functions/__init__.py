"""nearfield.functions"""
