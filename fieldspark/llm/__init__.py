"""Training-data operators: ten corpus operators over documents, benchmark items and chat logs.

Nothing else in the library imports this subpackage.
"""
