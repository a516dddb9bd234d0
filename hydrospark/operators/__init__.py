"""hydrospark.operators"""
