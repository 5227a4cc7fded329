"""Source-tree structure analytics on Spark DataFrames.

A project's files and import edges are two DataFrames (see ``schema``); every
operator takes those DataFrames and returns a lazy DataFrame.
"""
