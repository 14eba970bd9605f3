"""Training-data operators for very large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`upliftforge.llm.entry` registers the queries built on them.
"""
