"""Training-data operators: quality, deduplication, extraction, filtering, scanning and tokenizing of text corpora.

Nothing outside this folder imports it. ``registry`` lists the queries and their SQL.
"""
