"""threatscan.rules"""
