"""services"""
