"""sigloom.sources"""
