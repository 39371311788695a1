"""threatscan.functions"""
