"""Tables in and out: schemas, vendor files, the sentiment store, report files."""
