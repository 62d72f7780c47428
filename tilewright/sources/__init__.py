"""Readers and writers for the files a dataset is made of."""
