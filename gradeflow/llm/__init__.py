"""Training-data operators: one module per operator, plus ``queries`` with their registered queries.

Nothing outside this folder imports it; deleting it leaves the rest of the library whole.
"""
