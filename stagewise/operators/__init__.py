"""stagewise.operators"""
