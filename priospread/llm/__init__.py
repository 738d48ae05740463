"""Training-data operators: scans, deduplication, search, tokenising, packing, filters, scoring.

Each module holds one operator with a general interface; :mod:`.queries` holds the
thin ``opN_<name>`` queries and :mod:`.oracles` the SQL that checks them.
"""
