"""Training-data operators. Nothing outside this folder imports it.

Each module holds one operator with its own general interface, the thin query
that is registered for it and, where there is one, its SQL; ``registry`` lists them.
"""
