"""Readers, header specs, specs derived from data, and the text sink."""
