"""hydrospark.sources"""
