"""Training-data operators: packing, deduplication, tokenization, search, chat.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin registered queries.
"""
