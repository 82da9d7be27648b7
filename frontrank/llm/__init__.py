"""Operators for preparing training data: ten jobs over `documents` and `pages`.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
