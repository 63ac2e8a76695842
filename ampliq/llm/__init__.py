"""Training-data operators: counting tokens, finding near copies, cleaning, sharding and packing text at corpus scale.

Nothing outside this subpackage imports it.
"""
