"""Training-data operators: packing, scoring, fingerprints, near copies, token files, secrets, mixing.

Nothing outside this folder imports it; removing it leaves the timeline library whole.
"""
