"""Tables, label files and registries in; staged tables and JSON documents out."""
