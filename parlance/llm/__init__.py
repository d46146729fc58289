"""Operators for preparing training data at scale: thirteen dealt methods, one
module each, and the queries that apply them to whole tables (``queries``).

Every operator takes a DataFrame and the names of the columns it reads and
selects those columns first, so extra columns, whatever their names, never
clash with its own. Tasks hold one bounded block of rows at a time; a single
text is always processed whole.
"""
