"""stagewise.functions"""
