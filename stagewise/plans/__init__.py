"""stagewise.plans"""
