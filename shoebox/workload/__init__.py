"""The driver's tables seen as a media library, with one query and one SQL twin per operator."""
