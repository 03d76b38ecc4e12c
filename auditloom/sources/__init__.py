"""Scans: registers, records, drafts, evidence, held files and the release catalogue.

A root folder holds one folder per project. Every scan reads all projects at once; ``project_id``
is the folder name and ``rel_path`` the path below it.
"""
