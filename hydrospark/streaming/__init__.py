"""hydrospark.streaming"""
