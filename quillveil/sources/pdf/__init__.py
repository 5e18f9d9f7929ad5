"""PDF files without a PDF library: objects, text with places, redaction and cleaning of the file itself.

Covered: cross-reference tables and streams (objects are found by scanning, so
damaged tables do not matter), object streams, the text filters and Flate with
predictors, simple and composite fonts with or without Unicode maps, nested
forms. Encrypted files are reported, not opened; pixels are not rendered.
"""
