"""Tables, files, archives, delimited text and result sinks."""
