"""Training-data operators: text in, cleaned and packed training data out.

Each module holds one operator with a general interface; ``queries`` holds the thin
``opN_<name>`` queries over the standard tables.  Nothing outside this subpackage imports it.
"""
