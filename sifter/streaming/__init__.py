"""sifter.streaming"""
