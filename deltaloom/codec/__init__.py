"""The patch codec, for one pair of images at a time.

Its parts are sequential state machines, so they run in Python within an Arrow batch, a pair
per row; what leads up to them and what checks them is relational.
"""
