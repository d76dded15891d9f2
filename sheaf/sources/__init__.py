"""Sources and sinks: token corpora, PDF files, stored tables."""
