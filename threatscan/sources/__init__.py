"""threatscan.sources"""
