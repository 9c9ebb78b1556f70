"""Tables, scans, vendor layouts and writers."""
