"""Training-data operators: ten distributed operators and what they share.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
