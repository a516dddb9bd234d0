"""hydrospark.functions"""
