"""Training-data operators: thirteen components, one module each.

Every operator takes and returns DataFrames, reads only the columns it is told
to read (so extra columns never clash), treats a null text as empty and leaves
row order unspecified.  ``queries`` binds them to the synthetic tables.
"""
