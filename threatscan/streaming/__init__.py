"""threatscan.streaming"""
