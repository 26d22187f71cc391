"""Learning jobs: data split, autoencoder training, supervised model, retraining."""
