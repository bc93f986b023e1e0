"""Readers and writers of registers, series, stations and datasets."""
