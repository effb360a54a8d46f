"""Training-data operators: ten stages of a text pipeline, each a Spark job over whole tables.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
