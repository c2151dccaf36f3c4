"""Operators for preparing training data: ten jobs and the pipeline that chains five of them.

Nothing outside this subpackage imports it.
"""
