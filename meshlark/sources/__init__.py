"""Readers of topology documents, detector output, knowledge cards and price lists; writers of findings and documents."""
