"""hydrospark.plans"""
