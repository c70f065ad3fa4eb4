"""Readers: delimited rolls, fixed-width rolls, web pages, parcel rings, snapshots."""
