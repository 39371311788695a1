"""threatscan.operators"""
