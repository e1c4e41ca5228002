"""Training-data operators over document tables, and their named queries.

``queries.py`` registers one ``opN_<name>`` query per operator.  Nothing else in
the library imports this subpackage.
"""
