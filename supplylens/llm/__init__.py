"""Training-data pipeline operators.

Thirteen operators over ``documents``, ``pages``, ``benchmark``, ``labels``
and ``conversations``.  Nothing else in the library imports this subpackage;
``registry`` lists its queries and their SQL.
"""
