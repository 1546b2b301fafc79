"""Training-data operators for corpora far larger than one machine.

Each module holds one operator; `queries` applies all of them to the tables.
Nothing outside this package imports it.
"""
