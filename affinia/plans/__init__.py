"""Queries by users: guarded SQL, saved panels, and the registered queries of this library."""
