"""barloom.plans"""
